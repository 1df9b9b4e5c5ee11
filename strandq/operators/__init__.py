"""strandq.operators"""
