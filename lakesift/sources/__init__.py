"""lakesift.sources"""
