"""strandq.plans"""
