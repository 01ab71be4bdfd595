"""netweave.plans"""
