"""netloom.sources"""
