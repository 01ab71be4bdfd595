"""netweave.streaming"""
