"""lithoscope: structural analytics over source trees and document corpora, on Spark DataFrames."""
