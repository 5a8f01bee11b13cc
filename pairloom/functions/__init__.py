"""pairloom.functions"""
