"""netweave.functions"""
