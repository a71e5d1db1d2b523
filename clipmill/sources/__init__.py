"""clipmill.sources"""
