"""Batch jobs: state tables and requests in, new state tables, audit rows and outcomes out.

Every job is a pure function of its inputs, so a lost run is simply run again.
"""
