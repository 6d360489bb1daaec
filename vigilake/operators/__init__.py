"""vigilake.operators"""
