"""Analytics over corpora of typed trees and texts, as Spark DataFrame operations."""
