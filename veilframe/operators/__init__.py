"""veilframe.operators"""
