"""canopyloom.operators"""
