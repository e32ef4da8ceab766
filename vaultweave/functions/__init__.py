"""vaultweave.functions"""
