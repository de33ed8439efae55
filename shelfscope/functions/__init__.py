"""shelfscope.functions"""
