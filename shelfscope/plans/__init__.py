"""shelfscope.plans"""
