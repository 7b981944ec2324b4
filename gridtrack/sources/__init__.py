"""gridtrack.sources"""
