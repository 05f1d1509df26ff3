"""prismfield sources"""
