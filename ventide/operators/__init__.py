"""ventide.operators"""
