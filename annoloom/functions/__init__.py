"""annoloom.functions"""
