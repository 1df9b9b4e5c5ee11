"""strandq.streaming"""
