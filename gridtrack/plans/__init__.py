"""gridtrack.plans"""
