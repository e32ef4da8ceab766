"""vaultweave.sources"""
