"""psephon.sources"""
