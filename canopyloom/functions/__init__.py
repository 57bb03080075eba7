"""canopyloom.functions"""
