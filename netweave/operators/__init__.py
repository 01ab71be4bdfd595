"""netweave.operators"""
