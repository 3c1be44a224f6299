"""annoloom.streaming"""
