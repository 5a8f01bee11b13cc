"""pairloom.plans"""
