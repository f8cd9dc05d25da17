"""Whole reports composed from the operators.

study       fixed values of the territorial study
model       raw sources -> the seven model tables
reports     the four reports and the chart tables over the model
standins    the driver's tables seen as the model's tables
catalog     the registered queries
oracle      their SQL
"""
