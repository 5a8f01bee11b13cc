"""pairloom.operators"""
