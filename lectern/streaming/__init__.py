"""lectern.streaming"""
