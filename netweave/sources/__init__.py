"""netweave.sources"""
