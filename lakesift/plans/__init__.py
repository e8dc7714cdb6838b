"""lakesift.plans"""
