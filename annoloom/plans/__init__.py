"""annoloom.plans"""
