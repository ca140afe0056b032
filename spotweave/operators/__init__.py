"""spotweave.operators"""
