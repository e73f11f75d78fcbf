"""ventide.streaming"""
