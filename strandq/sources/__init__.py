"""strandq.sources"""
