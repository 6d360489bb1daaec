"""vigilake.streaming"""
