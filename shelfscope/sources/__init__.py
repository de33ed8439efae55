"""shelfscope.sources"""
