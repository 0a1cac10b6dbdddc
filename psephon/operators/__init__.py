"""psephon.operators"""
