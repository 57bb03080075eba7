"""canopyloom.sources"""
