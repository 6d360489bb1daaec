"""vigilake.sources"""
