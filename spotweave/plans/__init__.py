"""spotweave.plans"""
