"""gridtrack.operators"""
