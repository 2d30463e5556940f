"""Termloom: a terminology-analytics engine on Spark DataFrames."""
