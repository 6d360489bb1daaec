"""vigilake.functions"""
