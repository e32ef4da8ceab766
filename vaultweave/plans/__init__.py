"""vaultweave.plans"""
