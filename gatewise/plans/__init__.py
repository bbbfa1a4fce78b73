"""Whole queries over fixture or canonical tables, each registered with its reference SQL."""
