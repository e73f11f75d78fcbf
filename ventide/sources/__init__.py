"""ventide.sources"""
