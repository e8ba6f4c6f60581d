"""veilframe.streaming"""
