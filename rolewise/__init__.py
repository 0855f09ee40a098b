"""rolewise: rules over fact-oriented models, compiled to Spark DataFrame plans."""
