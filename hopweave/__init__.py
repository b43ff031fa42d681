"""hopweave: property-graph traversals and corpus operators as Spark DataFrame plans."""
