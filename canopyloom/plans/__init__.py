"""canopyloom.plans"""
