"""clipmill.streaming"""
