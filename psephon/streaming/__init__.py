"""psephon.streaming"""
