"""clipmill.functions"""
