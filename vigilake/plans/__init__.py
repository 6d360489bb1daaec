"""vigilake.plans"""
