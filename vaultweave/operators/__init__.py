"""vaultweave.operators"""
