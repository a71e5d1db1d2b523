"""clipmill.operators"""
