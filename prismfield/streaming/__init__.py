"""prismfield streaming"""
