"""prismfield plans"""
