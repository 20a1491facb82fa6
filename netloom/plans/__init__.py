"""netloom.plans"""
