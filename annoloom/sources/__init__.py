"""annoloom.sources"""
