"""shelfscope.streaming"""
