"""vaultweave.streaming"""
