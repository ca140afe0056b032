"""spotweave.streaming"""
