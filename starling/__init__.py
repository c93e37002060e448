"""starling: semi-supervised learning on graphs, and training-data operators, on Spark DataFrames."""
