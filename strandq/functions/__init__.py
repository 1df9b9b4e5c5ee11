"""strandq.functions"""
