"""psephon.functions"""
