"""The HTML element index and its selectors: the one operator that Spark has no expression for."""
