"""String functions as Column builders; each one also works inside array lambdas."""
