"""shelfscope.operators"""
