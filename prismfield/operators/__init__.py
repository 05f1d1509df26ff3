"""prismfield operators"""
