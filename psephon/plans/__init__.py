"""psephon.plans"""
