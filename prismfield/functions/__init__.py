"""prismfield functions"""
