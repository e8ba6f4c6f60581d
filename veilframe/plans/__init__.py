"""veilframe.plans"""
