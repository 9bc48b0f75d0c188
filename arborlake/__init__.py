"""Spark-native analytics over code changes, trees and text."""
