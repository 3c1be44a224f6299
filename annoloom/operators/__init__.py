"""annoloom.operators"""
