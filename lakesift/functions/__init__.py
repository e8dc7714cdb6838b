"""lakesift.functions"""
