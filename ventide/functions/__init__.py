"""ventide.functions"""
