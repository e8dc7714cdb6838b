"""lakesift.operators"""
