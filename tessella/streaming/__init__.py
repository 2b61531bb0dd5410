"""Workbooks and tables that arrive one after the other."""
