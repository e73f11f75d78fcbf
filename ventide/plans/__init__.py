"""ventide.plans"""
